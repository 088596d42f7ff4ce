import math
import random

import pytest
from pyspark.sql import functions as F

from tracemark.llm import hard_negatives as H

ROWS = "id long, label int, vector array<double>"


def brute(rows, positives, k, low, high, scale):
    """Plain loops over all pairs."""
    held = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.add((i, label, tuple(math.floor(scale * x) for x in v)))
    anchors = {}
    for i, label, v in held:
        if i % 5 == 0:
            anchors[i] = max(anchors.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, v) in anchors.items():
        scored = sorted({(-max(-2**63 + 1, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other) for i, other, w in held})
        for p, pos in [(-s, i) for s, i, other in scored if other == label and i != a][:positives]:
            found = [(i, -s) for s, i, other in scored if other != label and low * p <= 100 * -s <= high * p]
            out |= {(a, pos, rank, i, p, s) for rank, (i, s) in enumerate(found[:k], 1)}
    return out


def table(seed, n, dim, wide):
    rng = random.Random(seed)
    rows = [(rng.randrange(-5, n), rng.randrange(3), [rng.choice([0.0, 0.3, -0.1, rng.uniform(-1, 1)]) * wide for _ in range(dim)]) for _ in range(n)]
    return rows + rows[:6]  # repeated rows; ids come more than once, with other contents


@pytest.mark.parametrize("seed,n,dim,wide,cell,k,low,high", [(1, 150, 4, 1, (4096, 16384), 3, 50, 95), (2, 120, 3, 1, (7, 20), 3, 0, 100), (3, 90, 5, 1, (5, 9), 1, 80, 120),
                                                            (4, 60, 2, 3e14, (50, 30), 2, 50, 95), (5, 60, 2, 1e18, (50, 30), 3, 20, 99)])
def test_against_brute_force(spark, seed, n, dim, wide, cell, k, low, high):
    rows = table(seed, n, dim, wide)
    df = spark.createDataFrame(rows, ROWS).repartition(3).withColumns({"at": F.lit("clash"), "down": F.lit("clash"), "place": F.lit(1)})
    got = H.hard_negatives(df, F.col("id") % 5 == 0, k=k, low=low, high=high, scale=8, cell=cell).collect()
    clipped = [(i, label, [max(-2.0**60, min(2.0**60, x)) for x in v]) for i, label, v in rows]
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(clipped, 5, k, low, high, 8)


def test_nulls_and_empty(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 1.0]), (2, 2, [0.9, 0.4]), (3, None, [1.0, 1.0]), (4, 2, None), (6, 2, [None, 1.0]), (7, 2, [float("nan"), 1.0]),
            (8, 2, [float("inf"), 1.0]), (None, 2, [0.9, 0.4]), (9, 2, [0.8]), (11, 2, []), (12, 2, [0.9, 0.4, 5.0])]
    got = {tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("id") % 5 == 0, scale=100).collect()}
    assert got == {(0, 1, 1, 2, 15000, 11000), (0, 1, 2, 12, 15000, 11000), (0, 1, 3, 9, 15000, 8000)}  # ties by id; missing components are zeros
    assert H.hard_negatives(spark.createDataFrame([], ROWS), F.col("id") % 5 == 0).collect() == []


def test_slots_are_disjoint_and_cover_the_windows():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.randrange(-50, 400) for _ in range(rng.randrange(1, 6))]
        low, high = rng.choice([(50, 95), (0, 100), (80, 120)])
        slots = H.anchor_slots(scores, low, high)
        for s in range(-120, 500):
            inside = [j for j, (upper, lower) in enumerate(slots) if lower <= s <= upper]
            assert len(inside) <= 1
            if any(low * p <= 100 * s <= high * p for p in scores):
                assert len(inside) == 1


def test_a_label_of_a_third_of_all_rows_and_equal_vectors(spark):
    rows = [(i, 0 if i % 3 else i % 7, [1.0, 0.0] if i % 2 else [0.5, 0.1]) for i in range(400)]
    got = {tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("id") % 5 == 0, cell=(16, 64)).collect()}
    assert got == brute(rows, 5, 3, 50, 95, 256)
