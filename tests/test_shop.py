"""Names that are near by letters, against all pairs."""

import random
import unicodedata

from tidemill.operators import shop as op


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_near_names_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("강민배성문가 a") for _ in range(rng.randint(0, 4)))
    people = [(k, k % 2, name()) for k in range(60)] + [(60, 0, None)]
    letters = {k: unicodedata.normalize("NFD", "".join(n.split())) for k, _, n in people if n is not None}
    expected = {(a, b): d for a, g, n in people for b, h, m in people if a != b and g == h and n is not None and m is not None and (d := edits(letters[a], letters[b])) <= 2}
    found = op.near_names(spark.createDataFrame(people, "k long, g long, name string"), "k", "g", "name")
    assert {(r.k, r.other): r.distance for r in found.collect()} == expected and len(expected) > 50


def test_equal_names_meet_as_one(spark):
    """400 people of four names: what is compared are 4 names, not 160,000 pairs; the pairs come out whole."""
    rows = [(k, 1, ("김가나", "김 가나", "김가다", "박보라")[k % 4]) for k in range(400)] + [(1000, 2, "김가나"), (1001, None, "김가나"), (1002, 1, None)]
    found = op.near_names(spark.createDataFrame(rows, "k long, g long, name string"), "k", "g", "name")
    near = lambda a, b: a != b and (a % 4 == 3) == (b % 4 == 3)
    distance = lambda a, b: int((a % 4 == 2) != (b % 4 == 2))
    assert sorted(map(tuple, found.collect())) == [(a, b, distance(a, b)) for a in range(400) for b in range(400) if near(a, b)]
    shuffled = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("_key" in line and "_other" in line for line in shuffled.split("\n") if "Aggregate" in line)
