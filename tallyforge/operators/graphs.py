"""Catalogs of jobs that depend on each other: what is wrong with one, what a selection needs, and in which order it can run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.scratch import written


def faults(jobs: DataFrame, deps: DataFrame, phases: list[str]) -> DataFrame:
    """job, fault, detail. jobs: job, phase, units; deps: job, dep. Ids that occur twice, phases that aren't known, fewer than one unit, and dependencies on jobs that aren't there."""
    twice = jobs.groupBy("job").agg(F.count("*").alias("n")).filter("n > 1").select("job", F.lit("duplicate id").alias("fault"), F.col("n").cast("string").alias("detail"))
    phase = jobs.filter(~F.coalesce(F.col("phase").isin(*phases), F.lit(False))).select("job", F.lit("unknown phase").alias("fault"), F.col("phase").alias("detail"))
    units = jobs.filter(F.coalesce(F.col("units") <= 0, F.lit(True))).select("job", F.lit("no units").alias("fault"), F.col("units").cast("string").alias("detail"))
    unknown = deps.join(jobs.select(F.col("job").alias("dep")).distinct(), "dep", "left_anti").select("job", F.lit("unknown dependency").alias("fault"), F.col("dep").cast("string").alias("detail"))
    return twice.unionByName(phase).unionByName(units).unionByName(unknown)


def selection(jobs: DataFrame, deps: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the wanted jobs, the dependencies among them, jobs besides them that they depend on and that must have run before)."""
    chosen = jobs.filter(F.coalesce(wanted, F.lit(False)))
    ids = chosen.select("job").distinct()
    own = deps.join(ids, "job", "left_semi")
    inner = own.join(ids.withColumnRenamed("job", "dep"), "dep", "left_semi").select("job", "dep")
    before = own.join(ids.withColumnRenamed("job", "dep"), "dep", "left_anti").select(F.col("dep").alias("job")).distinct()
    return chosen, inner, before


def levels(jobs: DataFrame, deps: DataFrame) -> DataFrame:
    """job and level: 0 without dependencies, else one more than the highest level of those; null for jobs in a cycle or behind one.

    The frontier goes up by a level each round: jobs that are ready leave, and with them the dependencies on them. What is
    left is written each round and shrinks; there are as many rounds as levels.
    """
    left = written(jobs.select("job").distinct(), "jobs")
    open_ = written(deps.select("job", "dep").distinct(), "deps")
    done, level = None, 0
    while True:
        blocked = open_.select("job").distinct()
        ready = written(left.join(blocked, "job", "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else done.unionByName(ready)
        ids = ready.select("job")
        left = written(left.join(ids, "job", "left_anti"), "jobs")
        open_ = written(open_.join(ids.withColumnRenamed("job", "dep"), "dep", "left_anti").select("job", "dep"), "deps")
        level += 1


def checked_levels(jobs: DataFrame, deps: DataFrame) -> DataFrame:
    """The same; a cycle is an error that names some of its jobs."""
    out = written(levels(jobs, deps), "levels")
    stuck = [r[0] for r in out.filter("level is null").orderBy("job").limit(10).collect()]
    if stuck:
        raise ValueError(f"these jobs, and maybe others, wait for each other: {stuck}")
    return out
