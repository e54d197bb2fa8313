"""From labelled floors to an operating threshold and what it costs."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fewest labelled rows, and the rounds of the bootstrap.
FEWEST, ROUNDS = 200, 1000
#: Steps of the floor, which lies in [0, 1], by which rows are counted first.
BUCKETS = 4096
#: Random words made at once, so that they stay in a core's cache; partitions that groups are dealt over.
BLOCK, DEAL = 1 << 16, 128


def thresholds(labelled: DataFrame, target: float, *by: str, floor: str = "floor", label: str = "is_defect") -> DataFrame:
    """Per group: threshold (the floor at rank round(target * defects), half to even), achieved recall, false-positive rate and counts.

    Counts by BUCKETS steps of the floor tell in which step the rank falls; only that
    step's distinct floors are then put in order, so no task orders a whole group.
    """
    if not 0 < target <= 1:
        raise ValueError(f"target_recall {target} is not in (0, 1]")
    step = F.least(F.greatest(F.floor(F.col("floor") * BUCKETS), F.lit(0)), F.lit(BUCKETS))
    rows = labelled.select(*by, F.col(floor).cast("double").alias("floor"), F.col(label).cast("boolean").alias("bad")).withColumn("step", step)
    counts = (F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("step")
    coarse = rows.groupBy(*by, "step").agg(*counts)
    coarse = coarse.withColumn("n_positive", F.sum("bad").over(group)).withColumn("n", F.sum(F.col("bad") + F.col("good")).over(group))
    coarse = coarse.withColumn("bad_before", F.sum("bad").over(order) - F.col("bad")).withColumn("good_before", F.sum("good").over(order) - F.col("good"))
    rank = F.least(F.greatest(F.bround(F.lit(target) * F.col("n_positive")), F.lit(1)), F.col("n_positive"))
    hit = coarse.withColumn("rank", rank).where((F.col("bad_before") < F.col("rank")) & (F.col("rank") <= F.col("bad_before") + F.col("bad"))).drop("bad", "good")
    fine = rows.join(hit, [*by, "step"]).groupBy(*by, "floor", "rank", "n", "n_positive", "bad_before", "good_before").agg(*counts)
    order = Window.partitionBy(*by).orderBy("floor")
    fine = fine.withColumn("bad_to", F.col("bad_before") + F.sum("bad").over(order)).withColumn("good_to", F.col("good_before") + F.sum("good").over(order))
    at = fine.where(F.col("bad_to") >= F.col("rank")).groupBy(*by).agg(F.min_by(F.struct("floor", "bad_to", "good_to", "n", "n_positive"), "floor").alias("x"))
    if not by:
        at = at.where(F.col("x").isNotNull())
    negative = F.col("x.n") - F.col("x.n_positive")
    return at.select(*by, F.col("x.floor").alias("threshold"), F.lit(target).alias("target_recall"), (F.col("x.bad_to") / F.col("x.n_positive")).alias("achieved_recall"), F.when(negative > 0, F.col("x.good_to") / negative).otherwise(float("nan")).alias("fpr"), F.col("x.n").alias("n"), F.col("x.n_positive").alias("n_positive"))


class _Draws:
    """The numbers that random.Random(seed).randrange draws one by one, in its order, a block at a time.

    randrange(n) takes the top n.bit_length() bits of the next 32-bit word, again and again
    until they are below n; the words are the Mersenne twister's, which numpy has too.
    """

    def __init__(self, seed: int):
        *key, at = random.Random(seed).getstate()[1]
        self.twister, self.words = np.random.RandomState(), np.zeros(0, np.uint32)
        self.twister.set_state(("MT19937", np.array(key, np.uint32), at))

    def below(self, n: int, size: int) -> Iterator[np.ndarray]:
        """The next `size` numbers below n, in blocks."""
        if n >= 1 << 32:
            raise ValueError(f"{n} rows of a group are more than a 32-bit word can number")
        while size:
            if not len(self.words):
                self.words = self.twister.randint(0, 1 << 32, BLOCK, np.uint32)
            some, used = self.words >> np.uint32(32 - n.bit_length()), len(self.words)
            good = some < n
            if np.count_nonzero(good) > size:
                used = np.flatnonzero(good)[size - 1] + 1
            got = np.compress(good[:used], some[:used])
            self.words = self.words[used:]
            size -= len(got)
            yield got.astype(np.intp)


def _rank(n: int, target: float) -> int:
    return min(n - 1, max(0, round(target * n) - 1))


def _interval(pos: Sequence[float], neg: Sequence[float], target: float, seed: int) -> tuple[float, float]:
    if not len(pos) or not len(neg):
        raise ValueError("an interval needs both defect and clean examples")
    pos, neg, draws, rates = np.asarray(pos, float), np.asarray(neg, float), _Draws(seed), []
    rank = _rank(len(pos), target)
    for _ in range(ROUNDS):
        # drawn numbers are never out of range: clip only spares their check
        some = np.concatenate([pos.take(i, mode="clip") for i in draws.below(len(pos), len(pos))])
        under = neg <= np.partition(some, rank)[rank]
        rates.append(sum(int(np.count_nonzero(under.take(i, mode="clip"))) for i in draws.below(len(neg), len(neg))) / len(neg))
    rates.sort()
    return rates[int(0.025 * ROUNDS)], rates[min(ROUNDS - 1, int(0.975 * ROUNDS))]


def bootstrap(labelled: DataFrame, target: float, *by: str, seed: int = 0, floor: str = "floor", label: str = "is_defect", order: Column | str = "floor") -> DataFrame:
    """Per group its operating point, as `thresholds` has it, and the 2.5 and 97.5 per cent points of the false-positive rate over ROUNDS seeded resamples.

    Rows are drawn from one seeded generator, in `order`, so a group is one task's work,
    and the task takes the point from the rows it holds: `labelled` is worked out once.
    Groups are dealt over so many partitions that few of them share one. A case without a
    floor lies below all others.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("at", "ascending")]))
        floors, bad = group.column("floor").to_numpy(), group.column("bad").to_numpy().astype(bool)
        pos, neg = floors[bad], floors[~bad]
        low, high = _interval(pos, neg, target, seed)
        t = np.partition(pos, _rank(len(pos), target))[_rank(len(pos), target)]
        found = {"threshold": t, "achieved_recall": np.mean(pos <= t), "fpr": np.mean(neg <= t), "n": len(floors), "n_positive": len(pos), "fpr_low": low, "fpr_high": high}
        return pa.table({**{c: group.column(c).slice(0, 1) for c in by}, **{c: [x] for c, x in found.items()}})

    at = F.col(order) if isinstance(order, str) else order
    rows = labelled.select(*by, F.coalesce(F.col(floor).cast("double"), F.lit(float("-inf"))).alias("floor"), F.col(label).cast("boolean").alias("bad"), at.alias("at"))
    if by:
        rows = rows.repartition(max(DEAL, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
    kinds = "".join(f"`{c}` {labelled.schema[c].dataType.simpleString()}, " for c in by)
    return rows.groupBy(*by).applyInArrow(run, f"{kinds}threshold double, achieved_recall double, fpr double, n long, n_positive long, fpr_low double, fpr_high double")


def calibrate(labelled: DataFrame, target_recall: float = 0.95, seed: int = 0, min_labelled: int = FEWEST, by: tuple[str, ...] = (), floor: str = "floor", label: str = "is_defect", order: Column | str = "floor") -> DataFrame:
    """Operating points with intervals; too few rows, or rows of one class only, are an error."""
    if not 0 < target_recall <= 1:
        raise ValueError(f"target_recall {target_recall} is not in (0, 1]")
    counts = labelled.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(label).cast("boolean")).alias("p"))
    worst = counts.agg(F.min("n").alias("n"), F.min("p").alias("p"), F.min(F.col("n") - F.col("p")).alias("q")).first()
    if (worst.n or 0) < min_labelled:
        raise ValueError(f"{worst.n or 0} labelled rows are fewer than min_labelled={min_labelled}")
    if not worst.p or not worst.q:
        raise ValueError("calibrate needs both defect and clean examples")
    found = bootstrap(labelled, target_recall, *by, seed=seed, floor=floor, label=label, order=order)
    return found.select(*by, "threshold", F.lit(target_recall).alias("target_recall"), "achieved_recall", "fpr", "n", "n_positive", F.struct(F.col("fpr_low").alias("low"), F.col("fpr_high").alias("high")).alias("fpr_ci95"))
