"""Sessions: a local one for tests and benchmarks, and the package itself for the workers of any."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("packlens")
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is a shared one."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


class Cancelled(Exception):
    """The observer of a job asked it to stop."""


def observed(spark: SparkSession, work: Callable[[], object], observer: Callable[[int, int], bool], every: float = 0.2) -> object:
    """What ``work`` returns, all its Spark jobs being one group. ``observer`` is told, every so many
    seconds, how many of the group's tasks known so far are done and how many there are; if it returns
    False the group's jobs are cancelled and Cancelled is raised."""
    context, group, stop, asked = spark.sparkContext, f"observed-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    most = {}

    def look() -> tuple[int, int]:
        tracker = context.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            for stage in getattr(tracker.getJobInfo(job), "stageIds", ()):
                if (info := tracker.getStageInfo(stage)) is not None:
                    most[stage] = (max(info.numCompletedTasks, most.get(stage, (0, 0))[0]), info.numTasks)
        return sum(d for d, _ in most.values()), sum(n for _, n in most.values())

    def watch() -> None:
        while not stop.wait(every):
            if not observer(*look()):
                asked.set()
                context.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    context.setJobGroup(group, "observed", interruptOnCancel=True)
    watcher.start()
    try:
        return work()
    except Exception as error:
        if asked.is_set():
            raise Cancelled(group) from error
        raise
    finally:
        stop.set()
        watcher.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once an application; they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="packlens-code-")) / "packlens_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
