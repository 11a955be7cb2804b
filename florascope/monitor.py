"""Timers, resource samples, progress, checks of results and of the environment for runs of the stage graph."""

from __future__ import annotations

import functools
import importlib
import logging
import os
import resource
import sys
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("florascope")


def module_logger(name: str) -> logging.Logger:
    """A child of the package's logger, so that one level and one handler hold for all stages."""
    return log.getChild(name)


@dataclass
class Calls:
    n: int = 0
    seconds: float = 0.0
    longest: float = 0.0
    failed: int = 0


class Profiler:
    """Calls and seconds of decorated functions. Spark's plans are lazy: what is timed is the driver's part and the jobs it waits for."""

    def __init__(self) -> None:
        self.calls: dict[str, Calls] = {}
        self._lock = threading.Lock()

    def __call__(self, f: Callable) -> Callable:
        @functools.wraps(f)
        def timed(*args, **kwargs):
            began, ok = time.perf_counter(), False
            try:
                out = f(*args, **kwargs)
                ok = True
                return out
            finally:
                took = time.perf_counter() - began
                with self._lock:
                    c = self.calls.setdefault(f.__qualname__, Calls())
                    c.n, c.seconds, c.longest, c.failed = c.n + 1, c.seconds + took, max(c.longest, took), c.failed + (not ok)

        return timed

    def top(self, n: int = 10) -> list[tuple[str, Calls]]:
        return sorted(self.calls.items(), key=lambda x: -x[1].seconds)[:n]

    def bottlenecks(self, percent: float = 10.0) -> list[str]:
        """Functions that took at least percent of all seconds, slowest first."""
        total = sum(c.seconds for c in self.calls.values()) or 1.0
        return [name for name, c in self.top(len(self.calls)) if 100 * c.seconds / total >= percent]


@dataclass
class Usage:
    """Wall and CPU seconds of the driver, its largest memory (MB), and what Spark ran meanwhile."""

    seconds: float = 0.0
    cpu_seconds: float = 0.0
    peak_mb: float = 0.0
    jobs: int = 0
    stages: int = 0
    tasks: int = 0


@dataclass
class Track:
    """with Track(spark, 'stage') as t: ...; t.usage then says what the block used. Jobs are counted by their group."""

    spark: SparkSession
    name: str
    usage: Usage = field(default_factory=Usage)

    def __enter__(self) -> Track:
        self._began, self._cpu = time.perf_counter(), time.process_time()
        self.spark.sparkContext.setJobGroup(self.name, self.name)
        return self

    def __exit__(self, *_: object) -> None:
        t = self.spark.sparkContext.statusTracker()
        jobs = list(t.getJobIdsForGroup(self.name))
        stages = [s for j in jobs if (info := t.getJobInfo(j)) for s in info.stageIds]
        tasks = sum(x.numTasks for s in stages if (x := t.getStageInfo(s)))
        self.usage = Usage(
            time.perf_counter() - self._began, time.process_time() - self._cpu, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, len(jobs), len(stages), tasks)
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def progress(items: Iterable, total: int, label: str = "", out=None, width: int = 30) -> Iterator:
    """Passes items on and draws a bar with the time that is left; nothing is drawn where the output isn't a terminal."""
    out, began = out or sys.stderr, time.time()
    for k, x in enumerate(items, 1):
        yield x
        if getattr(out, "isatty", lambda: False)():
            done = int(width * k / max(total, 1))
            left = (time.time() - began) / k * (total - k)
            out.write(f"\r{label} [{'#' * done}{'.' * (width - done)}] {k}/{total} {left:.0f} s left" + ("\n" if k == total else ""))
            out.flush()


def check_table(df: DataFrame, columns: Iterable[str] = (), least: int = 1) -> list[str]:
    """What is wrong with a table: columns it lacks, rows it lacks; no more than `least` rows are read."""
    out = [f"column {c} is missing" for c in columns if c not in df.columns]
    if least and (n := df.limit(least).count()) < least:
        out.append(f"{n} rows of at least {least}")
    return out


def check_result(result: object) -> list[str]:
    """What is wrong with a stage's result: it needs a known status, lists of outputs and warnings, and seconds of at least 0."""
    out = []
    if getattr(result, "status", None) not in ("ok", "cached", "failed", "skipped"):
        out.append(f"status {getattr(result, 'status', None)!r} isn't known")
    out += [f"{name} isn't a list" for name in ("outputs", "warnings") if not isinstance(getattr(result, name, None), list)]
    if not isinstance(s := getattr(result, "seconds", None), int | float) or s < 0:
        out.append("seconds are missing")
    return out


def check_setup(spark: SparkSession, source: str, tables: Iterable[str] = ()) -> dict[str, object]:
    """Versions, the shared folder and the source tables, before a run."""
    from .session import shared_dir
    from .sources.readers import exists

    out: dict[str, object] = {"python": sys.version.split()[0], "spark": spark.version, "cores": spark.sparkContext.defaultParallelism}
    for m in ("numpy", "pandas", "pyarrow"):
        try:
            out[m] = importlib.import_module(m).__version__
        except ImportError:
            out[m] = None
    try:
        out["shared_folder"] = shared_dir(spark)
    except ValueError as e:
        out["shared_folder"] = f"missing: {e}"
    out["missing_tables"] = [t for t in tables if not exists(spark, os.path.join(source, f"{t}.parquet"))]
    out["ok"] = out["missing_tables"] == [] and all(out[m] for m in ("numpy", "pandas", "pyarrow")) and not str(out["shared_folder"]).startswith("missing")
    return out
