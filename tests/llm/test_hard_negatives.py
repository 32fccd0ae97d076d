"""Hard negatives by blocks and zone maps against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, block long, w string"


def plain(rows, positives=5, negatives=10, every=10):
    kept = [(k, i, [math.floor(256 * x) for x in v], y) for k, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda p, q: sum(x * y for x, y in zip(p[2], q[2]))
    order = lambda a: lambda r: (-score(a, r), r[1] is None, r[1] or 0)
    out = []
    for a in kept:
        if a[1] is None or a[1] % every:
            continue
        own = [r for r in kept if len(r[2]) == len(a[2])]
        for p in sorted((r for r in own if r[3] == a[3] and r[0] != a[0]), key=order(a))[:positives]:
            s = score(a, p)
            hard = [r for r in own if r[3] != a[3] and 30 * s <= 100 * score(a, r) <= 90 * s]
            out += [(a[1], p[1], k + 1, r[1], s, score(a, r)) for k, r in enumerate(sorted(hard, key=order(a))[:negatives])]
    return sorted(out, key=repr)


def mined(spark, rows, parts=3, **kw):
    table = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, hardneg.mine(table, F.col("vec_id") % 10 == 0, **kw).collect()), key=repr)


def vectors(n, dims, seed, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("block,chunk,spread", [(4, 5, 0.1), (256, 1024, 1.0)])
def test_equal_to_a_plain_search(spark, monkeypatch, block, chunk, spread):
    monkeypatch.setattr(hardneg, "CHUNK", chunk)
    monkeypatch.setattr(hardneg, "ZONES", 7)
    rng = random.Random(2)
    rows = [(k, v, rng.choice([0, 1, 2])) for k, v in enumerate(vectors(150, 6, 1, spread))]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, rows[0][1], 0)]  # ties
    rows += [(20, rows[20][1], 1), (20, rows[20][1], 1), (None, rows[3][1], 2), (None, rows[0][1], 1)]  # repeated and null keys
    rows += [(300, None, 1), (310, rows[1][1], None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (330, [float("nan")] * 6, 0), (340, [float("inf")] * 6, 1)]
    rows += [(400, [0.5, -0.25], 1), (401, [0.5, 0.5], 1), (402, [0.25, -0.125], 0), (410, [], 1), (411, [], 1), (412, [], 0)]
    expected = plain(rows)
    assert mined(spark, rows, block=block) == expected and len(expected) > 100


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 1]) * rng.uniform(2**20, 2**21) for _ in range(5)], k % 2) for k in range(40)]
    assert mined(spark, rows) == plain(rows)


def test_tables_without_anchors_or_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 0)]) == []


def test_blocks_out_of_reach_are_not_read(spark):
    rng = random.Random(7)
    rows = [(k, [(1 if k % 4 < 2 else -1) * (1 + rng.random() / 8) for _ in range(8)], k % 2) for k in range(200)]
    table = hardneg.arrange(spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA), "vec_id", "embedding", "label", F.col("vec_id") == 0, 256, 8)
    anchors = hardneg.anchors_of(table)
    asked = anchors.withColumn("windows", F.expr("array(named_struct('w', 1, 'low', 0L, 'high', 1000000L, 'floor', 0L))"))
    blocks, read = table.count(), hardneg.needed(asked, table, 2).count()
    assert 0 < read <= blocks / 2 + 1
    assert mined(spark, rows, block=8) == plain(rows)


def test_the_curve_visits_every_cell_once_and_moves_one_step():
    for dims, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        order = sorted(range(len(cells)), key=lambda k, p=hardneg.hilbert(cells, bits): p[k].tobytes())
        steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
        assert len({p.tobytes() for p in hardneg.hilbert(cells, bits)}) == len(cells) and (steps == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-99, 99, (7, 5)), rng.integers(-99, 99, (30, 5))
    least, most = hardneg.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    assert (least <= a @ b.T).all() and (most >= a @ b.T).all()
