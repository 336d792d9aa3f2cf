"""Session helpers: a session for local runs, and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A session for tests and the benchmark, with a scratch folder of its own. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("laurel")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", scratch or f"/tmp/laurel-{uuid.uuid4().hex}")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"/tmp/laurel-{sc.applicationId}"  # one machine: its folder is shared by all its tasks
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application. For the end of a job: results that read them are gone, too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/laurel-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a scratch table in the shared folder, under one folder per application."""
    application = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark)}/laurel-{application}/{name}-{uuid.uuid4().hex}"


TASK_ROWS = 250_000  # rows that a task joins and groups in memory


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks for a join or grouping of `rows` narrow rows, at least the session's; None for few rows, which AQE may merge.

    AQE sizes tasks by compressed shuffle bytes, and 64 MB of narrow rows are millions, which take gigabytes to sort and
    group.
    """
    if rows <= 4 * TASK_ROWS:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to so many tasks, which AQE leaves as they are; None leaves that to Spark."""
    return df if tasks is None else df.repartition(tasks, *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a scratch table in the shared folder: computed once, however many branches read them.

    Unlike a cache it survives lost executors, and its file sizes let Catalyst choose join sides by size.
    """
    path = scratch_path(df.sparkSession, name)
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are `stored` in here are deleted at the end, so what is left must not read them."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def together(*steps: Callable[[], None]) -> None:
    """Runs steps that do not need each other at once, so that the cores one leaves idle serve another. All come to an end
    before the first error is raised."""
    errors: list[BaseException] = []

    def of(step: Callable[[], None]) -> Callable[[], None]:
        context = copy_context()

        def run() -> None:
            try:
                context.run(step)
            except BaseException as e:  # noqa: BLE001
                errors.append(e)

        return run

    threads = [InheritableThread(target=of(step)) for step in steps[1:]]
    for t in threads:
        t.start()
    if steps:
        of(steps[0])()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
