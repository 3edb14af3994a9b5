"""The boundary to models: callables by import string, recognition backends by script, steps of a pipeline.

A model is any callable that maps one batch (a pandas frame) to another. It runs in ``mapInPandas``, so Spark deals out the work;
nothing here knows a model.
"""

from __future__ import annotations

import importlib
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[pd.DataFrame], pd.DataFrame]


def load_callable(spec: str) -> Batch:
    """The function that ``module.submodule:name`` names."""
    module, _, name = spec.rpartition(":")
    if not module.strip() or not name.strip():
        raise ValueError(f"{spec!r} is not of the form module:function")
    found = getattr(importlib.import_module(module.strip()), name.strip(), None)
    if not callable(found):
        raise TypeError(f"{spec} is not callable")
    return found


def apply_model(rows: DataFrame, spec: str | Batch, schema: str) -> DataFrame:
    """Rows through a model, batch by batch; an import string is resolved once in every worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_callable(spec) if isinstance(spec, str) else spec
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class Backend:
    """A recognition model and the scripts it reads (none: all of them)."""

    model: str | Batch
    scripts: frozenset[str] = frozenset()


@dataclass
class Backends:
    """Recognition backends by name."""

    known: dict[str, Backend] = field(default_factory=dict)

    def register(self, name: str, model: str | Batch, scripts: set[str] | None = None) -> None:
        self.known[name] = Backend(model, frozenset(scripts or ()))

    def recognise(self, pages: DataFrame, key: str, scripts: str = "scripts", calls: Calls | None = None) -> DataFrame:
        """``key, backend, text, n_lines, confidence, error`` of every page by every backend that reads one of its scripts
        (an array column). A page that fails is a row with an error, not a failure of the job."""
        out = None
        for name, backend in self.known.items():
            wanted = F.arrays_overlap(scripts, F.array(*map(F.lit, sorted(backend.scripts)))) if backend.scripts else F.lit(True)
            found = call_model(pages.where(wanted), backend.model, [key], "text string, n_lines long, confidence double", calls)
            found = found.select(key, F.lit(name).alias("backend"), "text", "n_lines", "confidence", "error")
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise ValueError("no backend is registered")
        return out


@dataclass(frozen=True)
class Calls:
    """How a model is called: rows a call, calls at a time and calls a second in a worker, attempts, and the pause before the second
    attempt (each later one is ``growth`` times as long)."""

    rows: int = 16
    concurrent: int = 4
    per_second: float | None = None
    attempts: int = 3
    pause: float = 0.5
    growth: float = 2.0
    sleep: Callable[[float], None] = time.sleep


class _Pace:
    """Hands out times at which calls may start, so many a second."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self, sleep: Callable[[float], None]) -> None:
        if self.gap:
            with self.lock:
                now = time.monotonic()
                start = max(now, self.next)
                self.next = start + self.gap
            if start > now:
                sleep(start - now)


def _answers(model: Batch, rows: pd.DataFrame, columns: list[str], calls: Calls, pace: _Pace, tried: int = 0) -> list[tuple]:
    """``columns, error, attempts`` of some rows by one call; rows whose call fails for good are halved, until a single one fails."""
    error = None
    for attempt in range(calls.attempts if len(rows) == 1 else max(1, calls.attempts - 1)):
        if attempt:
            calls.sleep(calls.pause * calls.growth ** (attempt - 1))
        pace.wait(calls.sleep)
        tried += 1
        try:
            got = model(rows)
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} answers to {len(rows)} rows")
            return [(*values, None, tried) for values in got[columns].itertuples(index=False, name=None)]
        except Exception as e:  # any failure of a model is an answer about its rows
            error = str(e)[:500]
    if len(rows) == 1:
        return [(*[None] * len(columns), error, tried)]
    half = len(rows) // 2
    return [x for part in (rows.iloc[:half], rows.iloc[half:]) for x in _answers(model, part, columns, calls, pace, tried)]


def call_model(rows: DataFrame, spec: str | Batch, keys: list[str], schema: str, calls: Calls | None = None) -> DataFrame:
    """``keys``, the columns of ``schema`` that the model gives, ``error`` and ``attempts`` for every row.

    A model gets some rows a call and answers one row each, in their order. Calls of a batch run in a bounded pool at a bounded
    rate and are tried again with growing pauses; a row that fails for good is a row with an error, and the rest of its call is done
    without it. So neither a flaky model nor a poison row fails a job.
    """
    calls = calls or Calls()
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    columns = [part.strip().split()[0] for part in re.split(r",(?![^<(]*[>)])", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, pace = load_callable(spec) if isinstance(spec, str) else spec, _Pace(calls.per_second)
        with ThreadPoolExecutor(calls.concurrent) as pool:
            for batch in batches:
                parts = [batch.iloc[i : i + calls.rows] for i in range(0, len(batch), calls.rows)]
                found = [x for part in pool.map(lambda p: _answers(model, p, columns, calls, pace), parts) for x in part]
                out = pd.DataFrame(found, columns=[*columns, "error", "attempts"], dtype="object")
                for k in reversed(keys):
                    out.insert(0, k, batch[k].to_numpy())
                yield out

    return rows.mapInPandas(run, f"{own}, {schema}, error string, attempts int")


def draw_lines(pages: DataFrame, spec: str | Batch, key: str) -> DataFrame:
    """``key, line_no, points`` of line masks: the model gives a frame of ``key, line_no, xs, ys`` for a batch of pages."""
    kind = pages.schema[key].dataType.simpleString()
    found = apply_model(pages, spec, f"{key} {kind}, line_no long, xs array<double>, ys array<double>")
    points = F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return found.select(key, "line_no", points.alias("points"))


def mask_points(mask, threshold: float = 0.5, most: int = 500) -> tuple[list[float], list[float]]:
    """Baseline of one mask (rows x columns): the median row of every column that has marks, at most ``most`` columns evenly."""
    import numpy as np

    on = np.asarray(mask) >= threshold
    columns = np.flatnonzero(on.any(axis=0))
    if len(columns) > most:
        columns = columns[np.linspace(0, len(columns) - 1, most).astype(int)]
    return [float(c) for c in columns], [float(np.median(np.flatnonzero(on[:, c]))) for c in columns]


def expand_lines(lines: DataFrame, spec: str | Batch, key: list[str], text: str) -> DataFrame:
    """Lines with ``expanded``, written out by a model (a frame of ``text`` to one of ``text``), and whether that changed them."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        own = load_callable(spec) if isinstance(spec, str) else spec
        out = batch.copy()
        out["expanded"] = own(batch[[text]].rename(columns={text: "text"}))["text"].to_numpy() if len(batch) else pd.Series([], dtype="object")
        return out

    found = apply_model(lines, run, f"{fields}, expanded string")
    return found.withColumn("changed", ~F.col("expanded").eqNullSafe(F.col(text)))


class Step(Protocol):
    """A step of a pipeline of pages: whether it applies, and what it makes of a frame."""

    name: str

    def applies(self, rows: DataFrame) -> bool: ...

    def run(self, rows: DataFrame) -> DataFrame: ...


def run_steps(rows: DataFrame, steps: list[Step]) -> tuple[DataFrame, list[str]]:
    """A frame through the steps that apply to it, and their names."""
    taken = []
    for step in steps:
        if step.applies(rows):
            rows = rows.transform(step.run)
            taken.append(step.name)
    return rows, taken
