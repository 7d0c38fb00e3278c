"""Session helpers shared by every operator: sessions for local work, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "sievewright", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only a local session may go without that setting; it then gets a folder of its own, removed at exit. A cluster without it is
    an error, since a folder of one machine would be lost with that machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sievewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + folder)
    return "file://" + folder


def run_dir(spark: SparkSession) -> str:
    """This application's own folder of tables; `clear` empties it, which also happens at exit."""
    return f"{shared_dir(spark)}/sievewright/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a compressed table into the shared folder and read it back.

    Cuts the lineage without tying blocks to one executor: a lost executor loses nothing of it. `release` removes the table as
    soon as nothing reads it any more; what a result still reads goes with `clear`.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(app)
        atexit.register(_clear_at_exit, spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._sievewright_path = path
    return table


_CLEARED_AT_EXIT: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(*tables: DataFrame) -> None:
    """Remove materialized tables that no frame reads any more; other frames are left alone."""
    for t in tables:
        path = getattr(t, "_sievewright_path", None)
        if path:
            _remove(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has materialized. Results that were not written or collected yet are lost."""
    _remove(spark, run_dir(spark))


def _clear_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped, or the JVM be gone
        if spark.sparkContext._jsc is not None:
            clear(spark)
