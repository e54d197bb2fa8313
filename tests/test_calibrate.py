from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcemark.operators.calibrate import ROUNDS, _Draws, _interval, bootstrap, calibrate, thresholds
from sourcemark.plans.queries import QUERIES


def labelled(n=400, gap=0.4, seed=7):
    draw = random.Random(seed)
    return [(min(1.0, max(0.0, draw.gauss(0.5 - gap / 2 if bad else 0.5 + gap / 2, 0.25))), bad) for bad in (i % 2 == 0 for i in range(n))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "floor double, is_defect boolean")


def test_recall_is_reached_and_interval_brackets(spark):
    rows = labelled()
    got = calibrate(frame(spark, rows)).first()
    bad, good = sorted(f for f, b in rows if b), [f for f, b in rows if not b]
    assert got.threshold == bad[round(0.95 * len(bad)) - 1]
    assert got.achieved_recall >= 0.95
    assert got.fpr == sum(f <= got.threshold for f in good) / len(good)
    assert got.fpr_ci95.low <= got.fpr <= got.fpr_ci95.high
    assert (got.n, got.n_positive) == (400, 200)
    assert (got.fpr_ci95.low, got.fpr_ci95.high) == _interval(bad, sorted(good), 0.95, 0)


def test_rank_is_half_to_even(spark):
    rows = [(i / 10, True) for i in range(10)] + [(1.0, False)]
    assert thresholds(frame(spark, rows), 0.85).first().achieved_recall == pytest.approx(0.8)


def test_cost_grows_with_recall_and_groups(spark):
    rows = frame(spark, labelled())
    assert thresholds(rows, 0.5).first().fpr <= thresholds(rows, 0.99).first().fpr
    assert thresholds(rows.selectExpr("*", "1 AS g"), 0.9, "g").first().g == 1


def test_refusals(spark):
    for rows, more, match in ((labelled(50), {}, "min_labelled"), ([(0.1, True)] * 300, {}, "both"), (labelled(), {"target_recall": 1.5}, "target_recall")):
        with pytest.raises(ValueError, match=match):
            calibrate(frame(spark, rows), **more)


def plain_interval(pos, neg, target, seed):
    """One draw after another."""
    draw, rates = random.Random(seed).randrange, []
    for _ in range(ROUNDS):
        some = sorted(pos[draw(len(pos))] for _ in pos)
        t = some[min(len(some) - 1, max(0, round(target * len(some)) - 1))]
        rates.append(sum(neg[draw(len(neg))] <= t for _ in neg) / len(neg))
    rates.sort()
    return rates[int(0.025 * ROUNDS)], rates[min(ROUNDS - 1, int(0.975 * ROUNDS))]


def test_draws_are_those_of_randrange():
    for seed in (0, -3, 2**70):
        plain, draws = random.Random(seed).randrange, _Draws(seed)
        for n, size in ((1, 3), (2, 5), (7, 1000), (65536, 70000), (65537, 70000), (5, 0), (2**31, 9), (2**32 - 1, 999)):
            assert [plain(n) for _ in range(size)] == [int(x) for block in draws.below(n, size) for x in block]


@pytest.mark.parametrize(("p", "q", "target", "seed"), [(1, 1, 0.95, 0), (3, 17, 0.5, 4), (64, 129, 0.95, 1), (100, 40, 1.0, 2)])
def test_interval_is_that_of_single_draws(p, q, target, seed):
    draw = random.Random(p)
    pos, neg = [round(draw.random(), 2) for _ in range(p)], [round(draw.random() + 0.2, 2) for _ in range(q)]
    assert _interval(pos, neg, target, seed) == plain_interval(pos, neg, target, seed)


def test_interval_of_many_rows_takes_little_time():
    draw, began = np.random.default_rng(3), time.process_time()
    low, high = _interval(draw.random(20000), draw.random(60000), 0.95, 0)
    assert low < 0.95 < high and time.process_time() - began < 8


def test_groups_have_the_points_of_thresholds_and_work_rows_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    rows = spark.createDataFrame([(f"g{i % 3}", i, f, b) for i, (f, b) in enumerate(labelled(600))], "g string, i long, floor double, is_defect boolean")
    got = {r.g: r for r in calibrate(rows.withColumn("floor", counted("floor")), by=("g",), order="i").collect()}
    assert calls.value == 600
    for r in thresholds(rows, 0.95, "g").collect():
        assert all(r[c] == pytest.approx(got[r.g][c], abs=1e-15) for c in r.asDict())
        own = [(x.floor, x.is_defect) for x in rows.where(F.col("g") == r.g).orderBy("i").collect()]
        assert tuple(got[r.g].fpr_ci95) == plain_interval([f for f, b in own if b], [f for f, b in own if not b], 0.95, 0)


def test_a_case_without_a_floor_lies_below_all(spark):
    rows = frame(spark, [(None, False), (0.5, True), (0.7, False), (0.2, False)])
    assert bootstrap(rows, 0.95).first().fpr == thresholds(rows, 0.95).first().fpr == pytest.approx(2 / 3)


def test_the_query_reads_its_cases_once_and_joins_nothing(spark, small):
    plan = QUERIES["calibrate_bootstrap"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
