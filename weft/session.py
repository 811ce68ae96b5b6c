"""Session helpers: builder defaults, table loading and materialisation in shared storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_folders: dict[str, tempfile.TemporaryDirectory] = {}

#: Rows that ``dealt`` means for a task, a fixed value.
ROWS_A_TASK = 500_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "weft") -> SparkSession:
    """A session with the settings that the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the star schema, as stored."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """Rows by their keys in as many tasks as ``n_rows`` rows ask for, whatever the session's number of partitions: so what a
    task sorts and counts in memory doesn't grow with the table. AQE leaves this number as it is."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_A_TASK))
    return rows.repartition(tasks, *keys)


def spread(rows: DataFrame) -> DataFrame:
    """Rows that grow with the tables, for a join that deals both sides by their keys: Spark takes a file's compressed size for that of
    its rows, so it would otherwise send millions of them whole to every executor."""
    return rows.hint("merge")


def share_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, wherever the driver was started."""
    root, own = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [root, own.get("PYTHONPATH", "")]))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a session that runs in this one process (``local[...]``, as in tests) may go without the setting: it gets a
    folder of its own, which goes with the process. Anything else is an error, as a machine's own folder isn't shared.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="weft-")
        found = "file://" + _own_folders[context.applicationId].name
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    _written.append((spark, path))


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them back.

    A written table costs one pass (``checkpoint()`` runs the last stage twice) and survives the
    loss of executors. The folders go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
