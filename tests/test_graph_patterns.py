"""Patterns of several edges against a walk along all of them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import graph as G
from gleaner.streaming.rounds import checkpointed


def plain(vertices, edges, ends, steps):
    edges = sorted({e for e in edges if e[0] in vertices and e[1] in vertices})
    found = Counter()

    def walk(path, used, at, number):
        if number == len(steps):
            found[*path, len(used)] += 1
            return
        relation, low, high = steps[number]

        def reach(at, used, n):
            if n >= low and (ends[number + 1] is None or ends[number + 1](at)):
                walk([*path, at], used, at, number + 1)
            if n < high:
                for e in edges:
                    if e[0] == at and (relation is None or e[2] == relation) and e not in used:
                        reach(e[1], [*used, e], n + 1)

        reach(at, used, 0)

    for v in sorted(vertices):
        if ends[0] is None or ends[0](v):
            walk([v], [], v, 0)
    return found


@pytest.mark.parametrize(
    ("first", "last", "steps"),
    [("a", None, [("x", 1, 1)]), (None, "b", [(None, 1, 3)]), ("a", "c", [("x", 0, 2), (None, 1, 1)]), (None, None, [("x", 1, 1), ("y", 1, 1), (None, 1, 1)]), ("absent", None, [(None, 1, 2)])],
)
def test_patterns(spark, first, last, steps):
    rnd = random.Random(len(steps))
    vertices = [f"{k}{i}" for k in "abc" for i in range(4)]
    edges = [(rnd.choice(vertices), rnd.choice(vertices), rnd.choice("xy")) for _ in range(30)] + [("a0", "outside", "x")]
    edges += edges[:3]
    starts = lambda p: None if p is None else F.col("id").startswith(p)
    plain_starts = lambda p: None if p is None else lambda v: v.startswith(p)
    middle = [None] * (len(steps) - 1)
    got = G.patterns(spark.createDataFrame([(v,) for v in vertices], "id string"), spark.createDataFrame(edges, "from_id string, to_id string, relation_type string"), [starts(first), *middle, starts(last)], steps, checkpointed)
    assert Counter(tuple(r) for r in got.collect()) == plain(set(vertices), edges, [plain_starts(first), *middle, plain_starts(last)], steps)


def test_a_leg_that_fails_is_missing(spark):
    found = G.legs(checkpointed, good=lambda: spark.range(3), late=lambda: spark.range(2).select(F.raise_error(F.lit("x"))), early=lambda: spark.range(1).select("absent"))
    assert found["good"].count() == 3 and found["late"] is None and found["early"] is None
