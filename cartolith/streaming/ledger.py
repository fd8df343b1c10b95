"""Job ledger: what is still to do, what happened, which state changes are legal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cartolith.functions.coords import spiral_cell, spiral_spec

# States and the changes they allow.
TRANSITIONS = {
    "PAUSED": ("RUNNING", "CANCELLED"),
    "RUNNING": ("PAUSED", "AUTO_PAUSED", "COMPLETED", "CANCELLED"),
    "AUTO_PAUSED": ("RUNNING", "PAUSED", "CANCELLED"),
    "COMPLETED": (),
    "CANCELLED": (),
}


def spiral_chunks(spark, center_x: int, center_z: int, radius: int) -> DataFrame:
    """Chunks of a square area with their place in nearest-first order."""
    spec = spiral_spec(center_x, center_z, radius)
    x, z = spiral_cell(F.col("id"))
    cells = spark.range(spec["ordinal_ceiling"]).select(F.col("id").alias("ordinal"), (x + spec["center_cx"]).alias("cx"),
                                                        (z + spec["center_cz"]).alias("cz"))
    return cells.filter(F.col("cx").between(spec["min_cx"], spec["max_cx"]) & F.col("cz").between(spec["min_cz"], spec["max_cz"]))


def remaining(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return planned.join(done.select(*key).distinct(), key, "left_anti")


def outcome_counts(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Completed, skipped and failed per job; runs on batches and, in update mode, on streams."""
    return results.groupBy(job).agg(*[F.count_if(F.col("outcome") == name).alias(name) for name in ("completed", "skipped", "failed")])


def _allowed() -> "F.Column":
    pairs = [F.lit(v) for name, targets in TRANSITIONS.items() for v in (name, ",".join(targets))]
    return F.split(F.create_map(*pairs)[F.col("previous")], ",")


def illegal_transitions(states: DataFrame, job: str = "job_id") -> DataFrame:
    """State changes (job, ts, state) that the rules forbid."""
    along = Window.partitionBy(job).orderBy("ts", "seq")
    changes = states.withColumn("previous", F.lag("state").over(along)).filter("previous IS NOT NULL AND previous <> state")
    return changes.filter(~F.array_contains(_allowed(), F.col("state")))


def resume_cursor(planned: DataFrame, done: DataFrame) -> DataFrame:
    """One row: the first place of the order that is not done yet, NULL when all is."""
    return remaining(planned, done, ["cx", "cz"]).agg(F.min("ordinal").alias("cursor"))
