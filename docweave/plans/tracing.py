"""K9: run traces as rows. A run's events are gathered and appended to the trace table when it ends."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class RunLog:
    """The events of one run, also of one that fails or is left by its reader. Without a folder nothing is kept."""

    def __init__(self, spark: SparkSession, folder: str, question: str, mode: str):
        self.trace_id = uuid.uuid4().hex
        self._spark, self._folder, self._began, self._closed = spark, folder, time.monotonic(), False
        # The names of the events and of their fields.
        self._rows: list[dict] = [{"event": "run_start", "trace_id": self.trace_id, "retrieval_mode": mode, "question": question}]

    def _milliseconds(self) -> int:
        return int(1000 * (time.monotonic() - self._began))

    def step(self, name: str, detail: dict) -> None:
        self._rows.append({"event": "step", "trace_id": self.trace_id, "step": name, "detail": detail, "ts_ms": self._milliseconds()})

    def close(self, citations: list[dict], iterations: int) -> None:
        """Adds the final event and appends all rows as JSON lines to the table in the folder, in one commit."""
        self._append({"event": "final", "citations": citations, "iterations": iterations})

    def fail(self, message: str, iterations: int) -> None:
        """As ``close`` for a run without an answer; a run that is closed stays as it is."""
        self._append({"event": "error", "message": message, "iterations": iterations})

    def _append(self, last: dict) -> None:
        if self._closed:
            return
        self._closed = True
        last = {**last, "trace_id": self.trace_id, "total_ms": self._milliseconds()}
        if self._folder:
            lines = [(json.dumps(row, ensure_ascii=False, default=str),) for row in [*self._rows, last]]
            self._spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(self._folder)
