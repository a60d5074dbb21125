"""The second stage as a stream: tasks with priority, retries and states that run out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds for which a state is kept, and how often a task is tried again.
KEPT = {"pending": 7200, "processing": 3600, "retry": 3600, "failed": 3600, "completed": 600}
RETRIES = 3


def ordered(tasks: DataFrame) -> DataFrame:
    """Tasks of the highest priority first, those of one priority by id."""
    return tasks.orderBy(F.desc("priority"), "artifact_id")


def two_stage(
    source: DataFrame,
    mark: Callable[[DataFrame], DataFrame],
    enhance: Callable[[DataFrame], DataFrame],
    first: str,
    second: str,
    checkpoint: str,
) -> tuple[StreamingQuery, Callable[[], StreamingQuery]]:
    """Stage one marks rows of the stream source and writes them to first; stage two, begun by the returned function,
    reads that folder as a stream, enhances each batch and writes it to second. Both drain what is there and stop."""
    marked = mark(source)
    one = marked.writeStream.format("parquet").option("path", first).option(
        "checkpointLocation",
        f"{checkpoint}/1",
    ).trigger(availableNow=True).start()

    def later() -> StreamingQuery:
        rows = marked.sparkSession.readStream.schema(marked.schema).parquet(first)
        return rows.writeStream.foreachBatch(
            lambda df, n: enhance(
                ordered(df) if "priority" in df.columns else df
            ).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{second}/batch={n}")
        ).option("checkpointLocation", f"{checkpoint}/2").trigger(availableNow=True).start()

    return one, later


def status(events: DataFrame, retries: int = RETRIES) -> DataFrame:
    """artifact_id, status, attempts, at from events (artifact_id, ts, event_id, outcome: queued, started, ok or error).

    The last event decides; an error is a retry until there were more than retries of them.
    """
    last = events.groupBy("artifact_id").agg(
        F.max(F.struct("ts", "event_id", "outcome")).alias("l"),
        F.count_if(F.col("outcome") == "error").alias("attempts"),
    )
    o = F.col("l.outcome")
    state = F.when(o == "queued", "pending").when(o == "started", "processing").when(o == "ok", "completed").when(
        F.col("attempts") > retries,
        "failed",
    ).otherwise("retry")
    return last.select("artifact_id", state.alias("status"), "attempts", F.col("l.ts").alias("at"))


def next_status(status: str | None, outcome: str, attempts: int, retries: int) -> tuple[str, int]:
    """The status after an event, and the errors so far."""
    attempts += outcome == "error"
    last = {"queued": "pending", "started": "processing", "ok": "completed"}.get(outcome)
    return last or ("failed" if attempts > retries else "retry"), attempts


def task_states(events: DataFrame, retries: int = RETRIES, late: str = "10 minutes") -> DataFrame:
    """artifact_id, status, attempts, at: status() of a stream, kept for each task until its time in KEPT runs out.

    events as for status(), with ts as the event time; events of one batch count in the order of (ts, event_id). A state
    whose time has run out by the watermark is told once more, as expired, and dropped; an event after that begins anew.
    """
    kind = events.schema["artifact_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda status, attempts, at: pd.DataFrame({"artifact_id": [key[0]], "status": [status], "attempts": [attempts], "at": [at]})
        status, attempts, at = state.get if state.exists else (None, 0, None)
        if state.hasTimedOut:
            state.remove()
            yield row("expired", attempts, at)
            return
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            status, attempts = next_status(status, e.outcome, attempts, retries)
            at = e.ts
        ends = int(at.timestamp() * 1000) + 1000 * KEPT[status]
        if ends <= state.getCurrentWatermarkMs():
            state.remove() if state.exists else None
            yield row("expired", attempts, at)
            return
        state.update((status, attempts, at))
        state.setTimeoutTimestamp(ends)
        yield row(status, attempts, at)

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("artifact_id").applyInPandasWithState(
        step,
        f"artifact_id {kind}, status string, attempts long, at timestamp",
        "status string, attempts long, at timestamp",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def unexpired(states: DataFrame, now: Column) -> DataFrame:
    """States whose time has not run out at now."""
    kept = F.create_map(*(F.lit(x) for kv in KEPT.items() for x in kv))
    return states.where(F.unix_timestamp(F.col("at").cast("timestamp")) + kept[F.col("status")] >= F.unix_timestamp(now.cast("timestamp")))


def responses(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Whole responses from their chunks."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda c: c[text]), "").alias(text))


def previous(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with prior_<value>: the value of the row before, in order, of the same key."""
    return df.withColumn(f"prior_{value}", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
