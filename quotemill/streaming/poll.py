"""Polling: cycles that stand alone, and a stream whose batches run a whole cycle."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..sources.landing import poll_interval


@dataclass
class Cycles:
    """What became of each cycle: the failures of one don't end the loop."""

    done: int = 0
    failed: dict[int, str] = field(default_factory=dict)
    pauses: list[int] = field(default_factory=list)


def poll(
    cycle: Callable[[int], object], hour: Callable[[], int], seconds: int, burst: int, start: int | None = None, end: int | None = None,
    max_cycles: int | None = None, sleep: Callable[[float], None] = time.sleep, report: Callable[[str], None] = print,
) -> Cycles:
    """Runs ``cycle`` again and again, more often in the burst hours. An error is reported with
    its kind, and the next cycle runs; an interrupt ends the loop."""
    out = Cycles()
    while max_cycles is None or out.done < max_cycles:
        try:
            cycle(out.done)
        except KeyboardInterrupt:
            break
        except Exception as e:  # noqa: BLE001  whatever a cycle meets, the next one may go well
            out.failed[out.done] = type(e).__name__
            report(f"cycle {out.done} failed: {type(e).__name__}")
        out.done += 1
        if max_cycles is None or out.done < max_cycles:
            pause = poll_interval(hour(), seconds, burst, start, end)
            out.pauses.append(pause)
            sleep(pause)
    return out


def stream_cycles(captures: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str, report: Callable[[str], None] = print):
    """A query that runs ``cycle`` (ingestion, detection, signal log) on each micro-batch.

    ``cycle`` gets the batch and its number, by which its writes must be idempotent. A batch that
    fails is tried again by the engine; what it can't read is the parser's to reject.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            cycle(batch, number)
            report(f"batch {number} done")

    return captures.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
