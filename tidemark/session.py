"""Session, shared folder and small driver-side file helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.host": "127.0.0.1",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").config(map=options).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests, one
    machine) a temporary folder is made and registered; on a cluster that
    would be a disk of one machine, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that no earlier call has returned."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


#: Tables written in each open ``scope`` of the running thread or task,
#: innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    lost executors cost a reread, not a recomputation.  Inside a ``scope`` the
    table lives until the scope ends."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if open_ := _SCOPES.get():
        open_[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables materialised inside are deleted at the end.  What shall outlive
    them goes through the function that is handed out: it writes the result
    for the scope around this one."""
    around, own = _SCOPES.get(), []
    token = _SCOPES.set((*around, own))

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _SCOPES.set(around)
        try:
            return materialise(df, label)
        finally:
            _SCOPES.reset(inner)

    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        for path in own:
            remove(spark, path)


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of any URI that Spark itself can open."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    fs, found = hadoop_path(spark, path)
    fs.delete(found, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per context: functions that run
    there are found by import, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file as long as it lives
    target = Path(folder) / "tidemark_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*")):
            if f.is_file() and "__pycache__" not in f.parts:
                out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
