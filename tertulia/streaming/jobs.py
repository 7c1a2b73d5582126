"""Jobs as a stream: events move each interview's job through its states; files of requests feed the queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job_id INT, interview_id INT, event STRING, step STRING, at TIMESTAMP"
STATE = "status string, step string, at timestamp"
OUT = "job_id int, interview_id int, status string, step string, interview_status string, at timestamp"

# Which event leads from which status to which, and what the interview's status then is.
MOVES = {("new", "enqueue"): "pending", ("pending", "start"): "running", ("running", "step"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed", ("pending", "fail"): "failed"}
INTERVIEW = {"pending": "pending_processing", "running": "processing", "completed": "completed", "failed": "failed"}


def moved(status: str, step: str | None, event: str, new_step: str | None) -> tuple[str, str | None, bool]:
    """(status, step, whether the event counts): final states take no event and clear the step."""
    to = MOVES.get((status, event))
    if to is None:
        return status, step, False
    return to, (new_step if to == "running" else None), True


def job_states(events: DataFrame) -> DataFrame:
    """R1 to R3 on a stream (or, in tests, a batch) of EVENTS: a row for each state that a job enters, in order of time within a micro-batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, step, at = state.get if state.exists else ("new", None, None)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            status, step, counts = moved(status, step, r.event, None if pd.isna(r.step) else r.step)
            if counts:
                at = r.at
                out.append((key[0], r.interview_id, status, step, INTERVIEW[status], at))
        if status != "new":
            state.update((status, step, at))
        yield pd.DataFrame(out, columns=["job_id", "interview_id", "status", "step", "interview_status", "at"])

    return events.groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as they arrive in a folder of JSON files."""
    return spark.readStream.schema(EVENTS).json(folder)


def run_queue(requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """R2: hands each micro-batch of requests to a handler; with once it drains what is there and stops."""
    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="4 seconds")).start()


def hourly_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Extension: (window, event_type, n, total) of event-time windows of an hour, late rows up to the watermark counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
