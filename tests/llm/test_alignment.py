"""Merge-path alignment of two tokenizers against plain loops over the libraries' own tokens."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemill.llm import align

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["x", " ", "  ", "a  b", "a \n  b", "é z", "x  y", "x　 y", "<|endoftext|> hi </s> <s> <0x41>", "▁", "a▁b", "tab\t x", "   lead", "trail  ", "\n", "\U0001f600 x", "漢字 か", "don't  we'll", "﻿ bom"]


@pytest.fixture(scope="module")
def plain():
    """(ids of A, ids of B, bytes of each) of a text, by the libraries on the whole text."""
    a = Tokenizer.from_file(str(public_tokenizers.path(A)))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(B)))
    both = align.tokenizers(A, B)

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [both.bytes_a[i] for i in ids[0]], [both.bytes_b[i] for i in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return ([], []), ([], [])
        return ids, parts

    return tokens


def aligned(ids, parts):
    """Links as index pairs and groups, found by looking at every byte."""
    owner = [[k for k, p in enumerate(side) for _ in p] for side in parts]
    links = sorted(set(zip(*owner)))
    ends = [set(np.cumsum([len(p) for p in side]).tolist()) for side in parts]
    groups, at = [], [0, 0]
    for end in sorted(ends[0] & ends[1]):
        group = []
        for side in (0, 1):
            own = []
            while at[side] < len(ids[side]) and sum(map(len, parts[side][: at[side] + 1])) <= end:
                own.append(str(ids[side][at[side]]))
                at[side] += 1
            group.append(",".join(own))
        groups.append("|".join(group))
    return [(ids[0][i], ids[1][j]) for i, j in links], groups


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "b", "é", " ", "  ", "\n", " ", "1", "!", "▁", "\U0001f600", "'s", "字", "ing", " the"]) for _ in range(rng.randint(1, 16))) for _ in range(120)]
    return [None, "", *ODD, *made, made[0], " ".join(made[:40])]


@pytest.mark.parametrize("work", [1, 5, 64])
def test_pieces_of_any_size_give_the_same_merge(plain, work):
    rows = texts()
    run = align.Run([(t or "").encode() for t in rows], align.tokenizers(A, B), work)
    for k, text in enumerate(rows):
        ids, parts = plain(text or "")
        links, groups = aligned(ids, parts)
        assert (run.n_a[k], run.n_b[k], run.n_groups[k]) == (len(ids[0]), len(ids[1]), len(groups)), text
        assert [divmod(p, align.PAIR) for p in run.pairs[run.starts[k] : run.starts[k + 1]].tolist()] == links
        assert run.digests[k] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_diagonals_split_any_two_lists_into_equal_work():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.append(np.unique(rng.integers(1, 60, rng.integers(1, 30))), 60) for _ in range(2))
        steps = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        taken = [0, *np.cumsum([side == 0 for _, side in steps]).tolist()]
        assert align.diagonals(a, b, np.arange(len(steps) + 1)).tolist() == taken


@pytest.mark.parametrize("size", [200, align.RUN])
def test_counts_are_corpus_wide(spark, plain, size):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block long, pair string").repartition(3)
    found = [aligned(*plain(t or "")) for _, t in rows]
    count = collections.Counter(p for links, _ in found for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    expected = collections.Counter()
    for (i, t), (links, groups) in zip(rows, found):
        ids, _ = plain(t or "")
        best = sum(count[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        expected[i, len(ids[0]), len(ids[1]), len(groups), len(links), best, sum(count[p] for p in links), digest] += 1
    out = align.align(docs, A, B, run_bytes=size)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, out.collect())) == expected


def test_empty_and_null_only_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(none, A, B).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert {tuple(r) for r in align.align(nulls, A, B).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")}


def test_a_very_long_text(spark):
    text = " ".join(f"word{k % 997}" for k in range(40_000))
    row = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    assert row.n_a > 40_000 and row.n_links == row.n_a + row.n_b - row.n_groups == row.count_sum
