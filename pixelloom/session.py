"""Session settings and the shared folder in which iterative operators cut their lineage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings the operators rely on; the caller's session wins where it sets them itself.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}


def build_session(master: str = "local[8]", app: str = "pixelloom", **conf: str) -> SparkSession:
    """A session for local use: tests, the bench and the command line."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", **DEFAULTS, **conf}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where that is unset and the
    session is a local one, a temporary folder of this machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = getattr(spark, "_pixelloom_folder", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="pixelloom-")
        spark._pixelloom_folder = known
    return known


class Staging:
    """Tables written to the shared folder and read back: they survive the loss of executors and
    cut the lineage.  A table is kept until :meth:`drop` or the end of the Spark application."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/pixelloom-{purpose}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        # Its tables serve results that are read later, so they go when the application does.
        atexit.register(self._delete_quietly)

    def _delete_quietly(self) -> None:
        with suppress(Exception):  # the session may be gone
            self._delete(self.root)

    def write(self, df: DataFrame, **observed: Column) -> DataFrame:
        """The table as written; ``observed`` are aggregates taken while it is, for :func:`seen_in`."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in observed.items()]).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pixelloom_path, out._pixelloom_seen = path, seen.get
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of :meth:`write` that nothing reads any more."""
        for table in tables:
            path = getattr(table, "_pixelloom_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def seen_in(table: DataFrame, name: str = "rows") -> int:
    """The number of rows of a table of :meth:`Staging.write`, or another aggregate observed there: it
    was taken while the table was written, without a job of its own."""
    return table._pixelloom_seen[name] or 0


@contextmanager
def staging(spark: SparkSession, purpose: str) -> Iterator[Staging]:
    """A :class:`Staging` whose tables are deleted if the block fails; after success the last ones
    must stay, because the result that the caller holds reads them lazily."""
    area = Staging(spark, purpose)
    try:
        yield area
    except BaseException:
        area._delete(area.root)
        raise


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """SQL settings for the block, then as they were before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def progress(spark: SparkSession, report: Callable[[int, int], None], seconds: float = 1.0) -> Iterator[None]:
    """Reports (done, total) tasks of the running stages every so often while the block runs, and once
    at its end.  A report that fails ends the reporting, never the work."""
    tracker, stop = spark.sparkContext.statusTracker(), threading.Event()

    def tick() -> None:
        stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
        report(sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages))

    def watch() -> None:
        with suppress(Exception):
            while not stop.wait(seconds):
                tick()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
        with suppress(Exception):
            tick()


def fan_out(spark: SparkSession, units: float, per_task: float) -> int:
    """Partitions for a stage of ``units`` rows (or bytes) in which a task takes about ``per_task``;
    at least two waves of tasks, so that a slow one is evened out."""
    cores = max(spark.sparkContext.defaultParallelism, 2)
    return int(max(2 * cores, min(100_000, -(-units // per_task))))
