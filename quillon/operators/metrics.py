"""Counts in the same pass: what a write, or a batch of a stream, counts on its way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(rows: DataFrame, name: str, measures: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows``, and an observation of aggregates over them that is there after the first action on them (``observation.get``)."""
    observation = Observation(name)
    return rows.observe(observation, *[m.alias(k) for k, m in measures.items()]), observation


def labels(column: str, known: list[str]) -> dict[str, Column]:
    """How often each known label stands in a column, and any other one (``other``); nulls are no label."""
    value = F.col(column)
    return {k: F.count_if(value == k) for k in known} | {"other": F.count_if(value.isNotNull() & ~value.isin(known))}


def kept(rows: DataFrame, reason: str, known: list[str], name: str = "kept", ok: str = "ok") -> tuple[DataFrame, Observation]:
    """The rows of reason ``ok``, with an observation that counts ``before``, ``after`` and every known reason on the way."""
    found = labels(reason, [ok, *[k for k in known if k != ok]])
    measures = {"before": F.count("*"), "after": found.pop(ok)} | found
    seen, observation = counted(rows, name, measures)
    return seen.where(F.col(reason) == ok), observation


def drop_ratio(found: dict) -> float:
    """Share of rows that went."""
    return round(1 - found["after"] / found["before"], 6) if found["before"] else 0.0


class ProgressLog(StreamingQueryListener):
    """One record a batch of a stream (``query, batch, rows``, observed counts), and the end of a query, to ``write``."""

    def __init__(self, write: Callable[[dict], None]):
        self.write = write

    def onQueryStarted(self, event) -> None:  # noqa: N802 (names of the library)
        self.write({"event": "start", "query": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.write({"event": "batch", "query": p.name, "batch": p.batchId, "rows": p.numInputRows} | {k: r.asDict() for k, r in p.observedMetrics.items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.write({"event": "end", "error": event.exception})
