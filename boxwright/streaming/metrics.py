"""Lifecycle of streaming jobs as a table: a query listener keeps one row for every start, progress and end."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "query string, event string, batch bigint, rows bigint, state_rows bigint, ms bigint, error string"


class Lifecycle(StreamingQueryListener):
    """Rows of the named queries (all by default), and callbacks by event: started, progress, ended."""

    def __init__(self, names: tuple[str, ...] = (), hooks: dict | None = None) -> None:
        self.rows, self.names, self.hooks, self.known = [], names, hooks or {}, {}

    def _add(self, run, event: str, batch: int | None = None, rows: int | None = None, state: int | None = None, ms: int | None = None, error: str | None = None) -> None:
        name = self.known.get(str(run))
        if name is not None and (not self.names or name in self.names):
            self.rows.append((name, event, batch, rows, state, ms, error))
            for hook in self.hooks.get(event, []):
                hook(self.rows[-1])

    def onQueryStarted(self, event) -> None:
        self.known[str(event.runId)] = event.name or str(event.id)
        self._add(event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = sum(o["numRowsTotal"] for o in p.get("stateOperators", []))
        self._add(p["runId"], "progress", p["batchId"], p["numInputRows"], state, p["durationMs"].get("triggerExecution", 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(event.runId, "ended", error=event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per event so far: a few for each micro-batch, whatever its size."""
        return spark.createDataFrame(self.rows, METRICS)
