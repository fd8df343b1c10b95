"""Health gate: closed on any problem, open again only after a stable stretch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class HealthPolicy:
    pause_when_players_online: bool = False
    minimum_tps: float = 18.0
    maximum_mspt: float = 50.0
    minimum_disk_gb: int = 5
    stable_seconds: int = 30


def health_reason(p: HealthPolicy) -> Column:
    """First problem of a snapshot in order of severity, NULL when healthy."""
    return (F.when(F.col("shutting_down"), "server-shutdown").when(F.col("recent_failure"), "recent-chunk-failure")
            .when(~F.col("dem_available"), "missing-dem-coverage").when(F.col("disk_gb") < p.minimum_disk_gb, "low-disk-space")
            .when(F.lit(p.pause_when_players_online) & (F.col("players") > 0), "players-online")
            .when(F.col("tps") < p.minimum_tps, "low-tps").when(F.col("mspt") > p.maximum_mspt, "high-mspt"))


def health_decisions(snapshots: DataFrame, policy: HealthPolicy, key: str = "server", bucket: str = "hour") -> DataFrame:
    """Decide every snapshot (key, ts, reason): may_dispatch and the reason shown.

    A key's history is cut into time buckets. Buckets are summarised first and the start of the
    healthy stretch is carried from summary to summary, so even a single key is worked on by
    many tasks.
    """
    rows = snapshots.withColumn("_b", F.date_trunc(bucket, "ts")).withColumn("_good", F.when(F.col("reason").isNull(), F.col("ts")))
    bad_at = F.when(F.col("reason").isNotNull(), F.col("ts"))
    last_bad = rows.groupBy(key, "_b").agg(F.max(bad_at).alias("_last_bad"))
    tails = (rows.join(last_bad, [key, "_b"]).groupBy(key, "_b").agg(F.max("_last_bad").alias("_last_bad"), F.min(F.when(
                 F.col("_last_bad").isNull() | (F.col("ts") > F.col("_last_bad")), F.col("_good"))).alias("_tail")))
    along = Window.partitionBy(key).orderBy("_b")
    runs = tails.withColumn("_run", F.sum(F.col("_last_bad").isNotNull().cast("int")).over(along))
    within = Window.partitionBy(key, "_run").orderBy("_b")
    carried = runs.withColumn("_upto", F.min("_tail").over(within)).withColumn("_in", F.lag("_upto").over(along)) \
                  .select(key, "_b", "_in")
    ordered = Window.partitionBy(key, "_b").orderBy("ts", "_rank")
    marked = (rows.withColumn("_rank", F.col("reason").isNotNull().cast("int")).join(carried, [key, "_b"], "left")
              .withColumn("_breaks", F.sum("_rank").over(ordered)))
    stretch = Window.partitionBy(key, "_b", "_breaks").orderBy("ts", "_rank")
    own = F.min("_good").over(stretch)
    since = F.when(F.col("_breaks") == 0, F.coalesce("_in", own)).otherwise(own)
    lasting = F.unix_micros("ts") - F.unix_micros("_since") >= policy.stable_seconds * 1_000_000
    return (marked.withColumn("_since", since)
            .withColumn("may_dispatch", F.col("reason").isNull() & F.coalesce(lasting, F.lit(False)))
            .withColumn("decision", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("may_dispatch"), "healthy").otherwise("stabilizing"))
            .select(*snapshots.columns, "may_dispatch", "decision"))


def health_stream(snapshots: DataFrame, policy: HealthPolicy, key: str = "server", delay: str = "1 minute") -> DataFrame:
    """The same gate over a stream. State per key is one timestamp; a micro-batch's rows of a key
    are put in time order before they are judged, so bound the batch at the source."""
    def judge(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts", kind="stable")
        allowed, shown = [], []
        for ts, reason in zip(rows["ts"], rows["reason"]):
            if reason is not None and not pd.isna(reason):
                since = None
                allowed.append(False)
                shown.append(reason)
                continue
            since = since or ts.value // 1000
            steady = ts.value // 1000 - since >= policy.stable_seconds * 1_000_000
            allowed.append(steady)
            shown.append("healthy" if steady else "stabilizing")
        state.update((since,))
        yield pd.DataFrame({key: [name[0]] * len(rows), "ts": rows["ts"], "may_dispatch": allowed, "decision": shown})

    kind = snapshots.schema[key].dataType.simpleString()
    return (snapshots.withWatermark("ts", delay).select(key, "ts", "reason").groupBy(key)
            .applyInPandasWithState(judge, f"{key} {kind}, ts timestamp, may_dispatch boolean, decision string",
                                    "since bigint", "append", GroupStateTimeout.NoTimeout))
