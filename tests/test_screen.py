"""Correlations in blocks and the greedy choice against plain code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import screen as S


@pytest.mark.parametrize("block", [3, 256])
def test_correlations_against_plain_code(spark, block):
    rng = random.Random(4)
    base = [rng.gauss(0, 1) for _ in range(120)]
    rows = [(e, t, base[t] * (e % 3) + rng.gauss(0, 1)) for e in range(9) for t in range(120) if rng.random() > (0.8 if e == 5 else 0.1)]
    rows += [(9, t, 1.0) for t in range(120)] + [(3, 119, None), (4, 500, float("nan"))]
    df = spark.createDataFrame(rows, "entity_id int, session_no int, return_1 double")
    got = {(r.as_of, r.left_id, r.right_id): (r.n, r.correlation) for r in S.pair_correlations(df, [60, 119, 119], window=30, least=20, block=block).collect()}
    value = {(e, t): x for e, t, x in rows if x is not None and x == x}
    assert len(got) == 2 * 45
    for (at, a, b), (n, c) in got.items():
        common = [t for t in range(at + 1) if (a, t) in value and (b, t) in value][-30:]
        assert n == len(common)
        x, y = [value[a, t] for t in common], [value[b, t] for t in common]
        if n < 20 or 9 in (a, b):
            assert c is None
        else:
            assert c == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_history_bounds_the_look_back(spark):
    df = spark.createDataFrame([(e, t, float((t * (e + 2)) % 7)) for e in range(2) for t in (1, 2, 3, 50, 51, 52)], "entity_id int, session_no int, return_1 double")
    assert [S.pair_correlations(df, [52], window=9, least=2, history=h).first().n for h in (None, 10)] == [6, 3]


@pytest.mark.parametrize("per_sector,most", [(None, None), (2, None), (1, 5), (3, 4)])
def test_choice_equals_going_down_the_list(spark, per_sector, most):
    rng = random.Random(7)
    people, pairs = [], []
    for day in range(6):
        n = rng.randint(1, 30)
        people += [(day, i, rng.choice(["a", "b", "c", None]), float(rng.randint(0, 9))) for i in range(n)]
        pairs += [(day, *sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 2 * n)) if n > 1]
    df = spark.createDataFrame(people, "day int, entity_id int, sector string, score double")
    conflict = spark.createDataFrame(pairs, "day int, left_id int, right_id int")
    order = [F.col("score").desc(), F.col("entity_id").cast("string")]
    got = sorted((r.day, r["rank"], r.entity_id) for r in S.greedy_choice(df, conflict, ["day"], order, per_sector=per_sector, most=most).collect())
    want = []
    for day in range(6):
        taken = []
        for _, i, s, _ in sorted((p for p in people if p[0] == day and p[2]), key=lambda p: (-p[3], str(p[1]))):
            clash = any((day, *sorted((i, j))) in set(pairs) for j, _ in taken)
            if not clash and (per_sector is None or sum(x == s for _, x in taken) < per_sector) and (most is None or len(taken) < most):
                taken.append((i, s))
                want.append((day, len(taken), i))
    assert got == sorted(want)
