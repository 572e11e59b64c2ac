"""Logs as JSON lines, counters of runs, progress of streams."""

from __future__ import annotations

import json
import logging
from collections import Counter
from datetime import UTC, datetime

from pyspark.sql.streaming import StreamingQueryListener

_PLAIN = set(vars(logging.makeLogRecord({})))


class JsonLines(logging.Formatter):
    """One JSON object a record, with the fields given as ``extra``."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "event": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in _PLAIN and k not in ("message", "asctime")}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


class Metrics:
    """Counters over runs: received, accepted, rejected, by status and by stage."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()

    def record(self, run: dict, rejected_by_stage: dict[str, int] | None = None) -> None:
        self.counts["runs"] += 1
        self.counts[f"status.{run['status']}"] += 1
        for k in ("records_received", "records_accepted", "records_rejected"):
            self.counts[k] += int(run.get(k) or 0)
        for stage, n in (rejected_by_stage or {}).items():
            self.counts[f"rejected.{stage}"] += n

    def snapshot(self) -> dict[str, int]:
        return dict(self.counts)


class Progress(StreamingQueryListener):
    """Logs rows and duration of every micro-batch."""

    def __init__(self, logger: logging.Logger) -> None:
        self.logger = logger

    def onQueryStarted(self, event) -> None:
        self.logger.info("stream.started", extra={"query": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.logger.info("stream.progress", extra={"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.logger.info("stream.ended", extra={"query": str(event.id), "error": event.exception})
