"""The life of a job as a fold over its events in order: queued, running, done, failed or canceled, with progress. For tables and for streams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "status string, progress int, page int, error string"
#: Codes of a process that was stopped, and the progress that a running job has at most.
STOPPED, MOST = (-15, -9, 137, 143), 95


@dataclass
class Job:
    status: str = "queued"
    progress: int = 0
    page: int = 0
    error: str | None = None
    cancel: bool = False

    def step(self, kind: str, value: str | None) -> None:
        """kind: start, line, exit (value: code, then ok if the result is there), cancel, restart, retry."""
        if kind == "start" and self.status == "queued":
            self.status = "running"
        elif kind == "line" and self.status == "running":
            if m := re.match(r"^===\s*(\d+)/(\d+)\s+", value or ""):
                self.progress = min(MOST, int(m[1]) * 100 // max(int(m[2]), 1))
            elif m := re.match(r"^page\s+(\d+):", value or ""):
                self.page = max(self.page, int(m[1]))
        elif kind == "exit" and self.status == "running":
            code, _, there = (value or "1").partition(" ")
            stopped, self.cancel = self.cancel or int(code) in STOPPED, False  # the wish to cancel is used up
            if stopped:
                self.status, self.error = "canceled", "cancelled by user"
            elif code == "0" and there == "ok":
                self.status, self.progress = "done", 100
            else:
                self.status, self.error = "failed", f"exit {code}"
        elif kind == "cancel" and self.status == "queued":
            self.status, self.error = "canceled", "cancelled before start"
        elif kind == "cancel" and self.status == "running":
            self.cancel = True
        elif kind == "restart" and self.status == "running":
            self.status, self.error, self.cancel = "failed", "interrupted by restart", False
        elif kind == "retry" and self.status in ("failed", "canceled"):
            self.__init__()


def history(events: DataFrame) -> DataFrame:
    """events (job, seq, kind, value) with the state after each. A job's rows arrive sorted, and only one job's state is held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, job = None, Job()
        for pdf in batches:
            rows = []
            for k, kind, value in zip(pdf["job"], pdf["kind"], pdf["value"]):
                if k != now:
                    now, job = k, Job()
                job.step(kind, value)
                rows.append((job.status, job.progress, job.page, job.error))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["status", "progress", "page", "error"])], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.repartition("job").sortWithinPartitions("job", "seq").mapInPandas(run, f"{kinds}, {OUT}")


def history_stream(events: DataFrame) -> DataFrame:
    """The same for a stream, the last state of each job in a batch."""
    def step(key, batches, state):
        job = Job(*state.get) if state.exists else Job()
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for kind, value in zip(rows["kind"], rows["value"]):
            job.step(kind, value)
        state.update(tuple(asdict(job).values()))
        yield pd.DataFrame([(key[0], int(rows["seq"].iloc[-1]), job.status, job.progress, job.page, job.error)], columns=["job", "seq", "status", "progress", "page", "error"])

    kind = events.schema["job"].dataType.simpleString()
    return events.groupBy("job").applyInPandasWithState(step, f"job {kind}, seq long, {OUT}", f"{OUT}, cancel boolean", "append", "NoTimeout")


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what ran has failed, what waited keeps its place by time. jobs: id, status, created_at, error."""
    from pyspark.sql import Window

    ran = F.col("status") == "running"
    at = F.when(F.col("status") == "queued", F.row_number().over(Window.partitionBy("status").orderBy("created_at", "id")))
    return jobs.withColumn("position", at).withColumns({"status": F.when(ran, "failed").otherwise(F.col("status")), "error": F.when(ran, "interrupted by restart").otherwise(F.col("error"))})
