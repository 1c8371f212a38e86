"""Heat by date over a stream of posts: the best documents of each step and cluster are kept as state.

A cluster of a step is split over ``PARTS`` keys by the hash of the post's id, so the largest cluster is no single task. The
state of a key is a count and at most ``take`` documents. When the watermark passes the end of the step, it is sent out
and removed; the rows merge as those of ``heat.window_tops`` do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heatloom.operators.heat import TOP_DOCS

PARTS = 16
_TOP = "p array<double>, doc_id array<long>, replies array<long>, age_s array<long>"
_OUT = f"start long, prediction long, post_num long, {_TOP}"


def _keep(take: int):
    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, prediction, _ = key
        if state.hasTimedOut:
            count, *top = state.get
            state.remove()
            yield pd.DataFrame({"start": [start], "prediction": [prediction], "post_num": [count]} |
                               {name: [list(x)] for name, x in zip(("p", "doc_id", "replies", "age_s"), top)})
            return
        count, rows = 0, []
        if state.exists:
            count, *top = state.get
            rows = list(zip(*top))
        for frame in frames:
            count += len(frame)
            best = frame.sort_values(["p", "doc_id"], ascending=[False, True]).head(take)
            rows += zip(*(best[c].tolist() for c in ("p", "doc_id", "replies", "age_s")))
            rows = sorted(rows, key=lambda r: (-r[0], r[1]))[:take]
        state.update((count, *map(list, zip(*rows))))
        state.setTimeoutTimestamp(max(int(end) * 1000, state.getCurrentWatermarkMs() + 1))
        yield from ()

    return keep


def stream_window_tops(posts: DataFrame, step: str, lateness: str = "1 day", take: int = TOP_DOCS, parts: int = PARTS) -> DataFrame:
    """``heat.window_tops`` of a streaming table of ``doc_id, prediction, p, replies, time``: rows of a step come out once
    ``lateness`` has passed behind it. Posts that come later still are left out, as are those without a
    time, a p or a cluster."""
    rows = posts.filter("time IS NOT NULL AND p IS NOT NULL AND prediction IS NOT NULL").withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", lateness)
    rows = rows.withColumn("_w", F.window("time", step)).select(
        F.unix_timestamp("_w.start").alias("start"), F.unix_timestamp("_w.end").alias("end"),
        F.col("prediction").cast("long").alias("prediction"), F.pmod(F.hash("doc_id"), F.lit(parts)).alias("part"), "time",
        F.col("p").cast("double").alias("p"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("replies").cast("long"), F.lit(0)).alias("replies"),
        (F.unix_timestamp("_w.end") - F.unix_timestamp("time")).alias("age_s"))
    kept = rows.groupBy("start", "end", "prediction", "part").applyInPandasWithState(
        _keep(take), _OUT, f"post_num long, {_TOP}", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.timestamp_seconds("start").alias("window_start"), "prediction", "post_num", F.arrays_zip("p", "doc_id", "replies", "age_s").alias("top"))
