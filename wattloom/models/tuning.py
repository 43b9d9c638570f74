"""Successive halving under a budget of trials and of wall-clock time.

Many settings start with few boosting rounds; the better part of them goes on with more, until one
group has run with all rounds. When the time is up nothing new starts and the jobs of running fits are cancelled by their tag;
the best settings of what has been finished are returned, so a search always has an answer
after its first fit. Settings that are compared have seen the same rounds.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.models.trees import BoostSpec, assemble, fit_early_stopped, fits_at_once, held, run_parallel
from wattloom.operators.metrics import regression_metrics


@dataclass(frozen=True)
class Ranges:
    """Tuning ranges; a log range is drawn on its scale. ``min_gain`` is the least gain of a split, which regularises."""

    step: tuple[float, float] = (0.01, 0.10)
    depth: tuple[int, int] = (4, 9)
    min_rows: tuple[int, int] = (2, 20)
    subsample: tuple[float, float] = (0.6, 1.0)
    column_share: tuple[float, float] = (0.5, 1.0)
    min_gain: tuple[float, float] = (1e-6, 1e-3)
    bins: tuple[int, ...] = (32, 64)


def draw_specs(trials: int, ranges: Ranges = Ranges(), seed: int = 42) -> list[BoostSpec]:
    """Seeded settings; trial i does not depend on how many there are."""
    import random
    out = []
    for i in range(trials):
        r = random.Random(f"{seed}-{i}")

        def scale(a: float, b: float) -> float:
            return a * (b / a) ** r.random()
        out.append(BoostSpec(step=scale(*ranges.step), depth=r.randint(*ranges.depth), min_rows=r.randint(*ranges.min_rows),
                             subsample=r.uniform(*ranges.subsample), features=f"{r.uniform(*ranges.column_share):.3f}",
                             min_gain=scale(*ranges.min_gain), bins=r.choice(ranges.bins), seed=seed))
    return out


class Deadline:
    """A point in time on ``clock``; a watch cancels the tagged Spark jobs of what still runs then."""

    def __init__(self, seconds: float | None, clock: Callable[[], float] = time.monotonic):
        self.clock, self.end = clock, None if seconds is None else clock() + seconds

    def passed(self) -> bool:
        return self.end is not None and self.clock() >= self.end

    def watch(self, spark: SparkSession, tag: str, done: threading.Event, every: float = 0.25) -> None:
        while not done.wait(every):
            if self.passed():
                spark.sparkContext.cancelJobsWithTag(tag)


def rungs(trials: int, least: int, most: int, factor: int) -> list[tuple[int, int]]:
    """(settings, rounds) of each rung: rounds grow by ``factor`` up to ``most``, settings shrink by it."""
    out, n, rounds = [], trials, min(least, most)
    while True:
        out.append((n, rounds))
        if rounds >= most:
            return out
        n, rounds = max(1, -(-n // factor)), min(most, rounds * factor)


TRIALS = ("trial int, rung int, rounds int, loss double, stopped boolean, step double, depth int, min_rows int, "
          "subsample double, column_share double, min_gain double, bins int")


def halving(specs: Sequence[BoostSpec], loss: Callable[[BoostSpec], float], deadline: Deadline, least: int = 8, most: int = 100,
            factor: int = 3, run: Callable[[list[Callable]], list] | None = None) -> tuple[BoostSpec | None, list[tuple]]:
    """Best settings and one row per started or stopped (trial, rung).

    ``loss`` fits settings with their own ``max_iter``; it may raise after the deadline, which stops that
    trial only. The best is the least loss of the highest rung that has one; ties go to the earlier trial.
    """
    run = run or (lambda tasks: [t() for t in tasks])
    rows: list[tuple] = []
    alive = list(range(len(specs)))
    best: tuple[int, float, int] | None = None
    for rung, (n, rounds) in enumerate(rungs(len(specs), least, most, factor)):
        alive = alive[:n]

        def one(i: int) -> float | None:
            if deadline.passed():
                return None
            try:
                return loss(specs[i].with_(max_iter=rounds))
            except Exception:
                if deadline.passed():
                    return None
                raise
        found = dict(zip(alive, run([lambda i=i: one(i) for i in alive])))
        for i in sorted(alive):
            s = specs[i]
            rows.append((i, rung, rounds, found[i], found[i] is None, float(s.step), s.depth, s.min_rows, float(s.subsample),
                         float(s.features), float(s.min_gain), s.bins))
        finished = sorted((v, i) for i, v in found.items() if v is not None)
        if finished:
            best = (rung, *finished[0])
        if deadline.passed() or not finished:
            break
        alive = [i for _, i in finished]
    return (specs[best[2]].with_(max_iter=rungs(len(specs), least, most, factor)[best[0]][1]) if best else None), rows


def tune(df: DataFrame, features: Sequence[str], target: str, trials: int = 60, seconds: float | None = 30 * 60,
         split: str = "split", weight: str | None = None, ranges: Ranges = Ranges(), seed: int = 42, least: int = 8, most: int = 100,
         factor: int = 3, parallelism: int = 4, clock: Callable[[], float] = time.monotonic) -> tuple[BoostSpec | None, DataFrame]:
    """Search on train rows, judged by 1 - R2 on val rows (on train rows if there are none); no other split is read."""
    spark = df.sparkSession
    deadline = Deadline(seconds, clock)
    frame = assemble(df.filter(F.col(split).isin("train", "val") & F.col(target).isNotNull()), features)
    frame = held(frame.select(split, "features", target, *([weight] if weight else [])))
    sizes = {r[0]: r[1] for r in frame.groupBy(split).count().collect()}
    judged = frame.filter(F.col(split) == ("val" if sizes.get("val") else "train"))
    tag, done = f"tune-{uuid.uuid4().hex}", threading.Event()

    def loss(spec: BoostSpec) -> float:
        spark.sparkContext.addJobTag(tag)
        try:
            model = fit_early_stopped(frame, target, spec, split, weight=weight)
            return 1 - regression_metrics(model.transform(judged), target, "prediction").first().r2
        finally:
            spark.sparkContext.removeJobTag(tag)

    watch = threading.Thread(target=deadline.watch, args=(spark, tag, done), daemon=True)
    watch.start()
    try:
        best, rows = halving(draw_specs(trials, ranges, seed), loss, deadline, least, most, factor,
                             lambda tasks: run_parallel(tasks, fits_at_once(sum(sizes.values()), parallelism)))
    finally:
        done.set()
        watch.join()
        frame.unpersist()
    return best, spark.createDataFrame(rows, TRIALS)
